"""Column functions: hashing, paths, rectangle arithmetic and colour arithmetic."""
