"""DataFrame operators: master dataset, features, statistics, training, forecast, snapshot, scoring."""
