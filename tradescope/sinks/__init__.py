"""Writers: each takes rows and a folder, writes there, and can be run again."""
