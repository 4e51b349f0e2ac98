"""corpusrisk: labelled text / source-code corpus mining, vectorising, modelling and
scoring as Spark DataFrame operators.

Sub-packages
------------
functions   column expressions (regex tokenisers, seeded uniforms, ids, vectors)
operators   DataFrame-in / DataFrame-out operators (vocabulary, evaluation, lineage,
            synthetic sequences, pooling, prefix sums, models)
sources     readers for feeds, dataset indexes, content trees, run results
sinks       writers for the relational tables, datasets, corpora, run results
plans       end-to-end jobs and the query catalogue run on the driver tables
streaming   incremental (Structured Streaming) corpus cleaning
"""

__version__ = "0.1.0"
