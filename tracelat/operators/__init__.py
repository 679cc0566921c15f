"""DataFrame operators: filters, pairing, as-of settings, statistics,
control-log replay and catalogue queries."""
