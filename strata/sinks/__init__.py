"""Writers: CSV, INSERT text, JSON rows and the run log."""
