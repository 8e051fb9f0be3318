"""Sources: webhook bodies, message queues (files or Kafka), results history,
chart points and log files."""
