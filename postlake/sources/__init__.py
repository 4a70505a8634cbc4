"""Feed normalizers and file sources."""
