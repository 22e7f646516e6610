"""Where inputs come from: file collections, byte tables, models."""
