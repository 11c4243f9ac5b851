"""inkwell: a knowledge-graph analytics engine for markdown notes, declared as Spark plans."""
