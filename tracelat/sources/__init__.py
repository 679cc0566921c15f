"""Sources and sinks: trace tables, binary samples, catalogue files, test adapters."""
