"""Plans over logs of operations: folds, transactions, statistics, snapshots, replication, clusters."""
