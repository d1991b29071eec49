"""Column functions: text, numbers, JSON, hashes and conservative merging. All run inside the JVM except where a docstring says otherwise."""
