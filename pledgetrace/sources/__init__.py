"""Reading and writing the files and tables of the commitment model."""
