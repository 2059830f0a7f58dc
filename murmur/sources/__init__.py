"""Sources and sinks: message CSVs, word lists, score logs, corpora."""
