"""Sources and sinks: conversations, fingerprint tables, archives, experiment results."""
