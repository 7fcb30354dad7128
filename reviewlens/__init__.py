"""reviewlens: review and feedback analytics as Spark DataFrame operators.

Every public operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function. Sub-packages:

* ``functions``  Column builders: text cleaning, token lookups, sentiment math, formatting.
* ``operators``  DataFrame operators: roles, profiling, ratings, sentiment charts,
                 time, sampling, mismatches, prompts, scoring.
* ``sources``    CSV / JSON / Excel scans, dispatch by extension, CSV sink, preview.
* ``plans``      Composed flows (the ``reviews`` view, flagship query, query catalog).
* ``streaming``  Structured Streaming variants of the stateless operators.
"""

from reviewlens.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
