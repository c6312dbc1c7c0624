"""Raw text input, table output and the fixed layouts of the raw sources."""
