"""probity: Spark-native auditing of classifier evaluations and of the tables behind them."""
