"""Column functions: text cleaning, tokens, time codes, fingerprints, and Arrow UDFs."""
