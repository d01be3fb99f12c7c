"""Layer builders and jobs: bronze to silver, silver to gold, cards and reports."""
