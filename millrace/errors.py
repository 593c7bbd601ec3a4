"""Errors, each of which ends a pipeline with exit code 1."""

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException


class MillraceError(Exception):
    """The root of all."""


class SourceError(MillraceError):
    """Data could not be fetched or read."""


class StoreError(MillraceError):
    """A store could not be read or written."""


class SampleError(MillraceError):
    """A sample could not be made."""


class CheckError(MillraceError):
    """A precondition or contract does not hold."""


class EnrichmentError(MillraceError):
    """An enrichment could not be made."""


#: What ends a pipeline with exit code 1: errors of this package, of Spark on either side, and of the file system.
FAILURES = (MillraceError, PySparkException, Py4JError, OSError)
