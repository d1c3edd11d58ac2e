"""What a user calls: whole runs composed from the operators."""
