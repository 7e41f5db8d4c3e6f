"""Sources: files, formats, pages, logs and settings as DataFrames."""
