"""DataFrame to DataFrame operators; all lazy, none keeps module state."""
