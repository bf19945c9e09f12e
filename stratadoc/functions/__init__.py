"""Part of stratadoc; see README.md."""
