"""Text, vector and corpus operators for preparing training data."""
