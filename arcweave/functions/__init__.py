"""Column functions: text, predicates, the concept lexicon and scores."""
