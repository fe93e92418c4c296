"""quern.operators."""
