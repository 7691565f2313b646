"""Column expressions: text dialects, numbers, places, extraction.  Everything stays in the JVM
unless a function says otherwise."""
