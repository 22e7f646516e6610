"""Column functions, and the small numpy helpers that tasks call per image."""
