"""Datasets: catalog, snapshots, indexes, transactions."""
