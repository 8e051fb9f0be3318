"""DataFrame operators: keyed scan, chart series, build bookkeeping, webhook
intake, results, logs, joins."""
