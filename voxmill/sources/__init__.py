"""Reading review files, small dimension tables and stored results; writing results."""
