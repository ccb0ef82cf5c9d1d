"""Nothing here reads an unbounded source: cohorts are tables, and generation is a bounded set of blocks.

The operators are plain DataFrame transformations, so those without windows or global order (allele explosion, classes,
checks, decoding, rendering) can be applied to ``readStream`` frames as they are.
"""
