"""Programs: from nested calls to one DataFrame."""
