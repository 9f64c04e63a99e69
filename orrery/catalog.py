"""All queries of the engine and the SQL they are compared with."""

from __future__ import annotations

from orrery.plans import bayes_svm, models, reports

QUERIES = {**bayes_svm.QUERIES, **models.QUERIES, **reports.QUERIES}
ORACLE_SQL = {**bayes_svm.ORACLE_SQL, **models.ORACLE_SQL, **reports.ORACLE_SQL}
