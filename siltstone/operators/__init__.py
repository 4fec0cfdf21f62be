"""Key-value, time-series and compaction operators over ordered logs."""
