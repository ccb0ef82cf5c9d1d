"""Sources and sinks: variant text, profiles, BGZF, BCF, indexes."""
