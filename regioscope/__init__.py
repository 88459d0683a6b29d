"""regioscope: regional innovation and entrepreneurship analytics on Spark.

Every public operator takes and returns DataFrames (use them through
``df.transform``) or returns Columns, so that one plan runs unchanged on a
laptop and on a cluster.  Sub-packages:

* ``functions``  column expressions (R semantics, text, dates, geometry)
* ``sources``    readers and writers (CSV, JSON cubes, polygon layers, sinks)
* ``operators``  DataFrame -> DataFrame operators (aggregation, windows,
                 joins, sampling, spatial joins, complexity, composite index,
                 trend, ML pipelines)
* ``plans``      end-to-end query plans bound to the test tables
* ``streaming``  incremental roll-up of snapshot folders
"""

from regioscope.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
