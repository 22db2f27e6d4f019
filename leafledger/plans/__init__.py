"""The change log and what follows from it: state, sets, snapshots, transactions."""
