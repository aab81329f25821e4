"""brindle: knowledge-base, conversation and trace analytics expressed as Spark DataFrame programs."""
