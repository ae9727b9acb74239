"""DNA-methylation analytics as lazy Spark plans.

``functions``  column expressions, ``operators``  DataFrame -> DataFrame steps,
``sources``  readers and sinks, ``plans``  the end-to-end flows built from them,
``workloads``  the registered queries with their SQL counterparts.
"""

from epispark.params import RRBS_HG19, WGBS_GRCH38, Params

__all__ = ["Params", "RRBS_HG19", "WGBS_GRCH38"]
