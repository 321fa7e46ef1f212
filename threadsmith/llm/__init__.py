"""Training-data operators.  Each module holds one operator with its general
interface; ``queries.py`` binds them to the registered ``opN_*`` queries.
Nothing outside this folder imports it, except ``corpus_pipeline.py``."""
