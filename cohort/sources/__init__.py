"""Reading tables, profiling what is declared about them, and writing results."""
