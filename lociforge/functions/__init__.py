"""Column functions: alleles, genotypes, field declarations, text."""
