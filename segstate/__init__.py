"""segstate: hidden semi-Markov sequence analytics on Spark.

Layout
------
- ``sources``    sequence building from event tables, typed readers/writers,
                 model / trace / metrics tables.
- ``functions``  Column-level building blocks (observation arrays, L1
                 normalisation, deterministic hashing, parameter init).
- ``operators``  relational operators: folds and row ids, forward scoring,
                 E-step kernel, M-step, long-form recursions, evaluation.
- ``plans``      multi-job plans: the EM loop over all models and the
                 k-fold cross-validation jobs.
- ``streaming``  the scoring plan applied to a streaming sequence source.
"""

from segstate.spec import HsmmSpec

__all__ = ["HsmmSpec"]
