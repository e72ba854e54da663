"""rulespan: a deductive analytics engine whose physical layer is Spark."""
