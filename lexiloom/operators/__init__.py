"""DataFrame transforms: corpus statistics, vectors, taggers, chunkers, extraction."""
