"""One registered query per operator."""
