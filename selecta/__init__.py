"""selecta: choose, prepare and evaluate instruction-tuning data with Spark.

Everything is a DataFrame operator. Sub-packages:

- ``sources``   table readers, fixture views, file sinks
- ``functions`` column expressions (tokens, templates, ROUGE, vectors)
- ``operators`` composite operators (ranking, features, regions, selection,
                evaluation, clustering, reports)
- ``plans``     named queries with their SQL oracles
- ``streaming`` resumable incremental jobs on Structured Streaming
"""

from selecta.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
