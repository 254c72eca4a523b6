"""Reading and writing of the files that users exchange."""
