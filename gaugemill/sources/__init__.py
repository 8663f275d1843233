"""Sources and sinks: truth documents, responses, look-ups, results."""
