"""Column functions: message records, timestamps, codecs, list/map/enum text."""
