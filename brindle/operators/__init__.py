"""Statistics, versions, ordered keys, transactions, backup."""
