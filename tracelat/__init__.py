"""tracelat — kernel-call trace latency analytics on Spark.

Raw entry/exit events -> filters (with as-of run-time settings) -> keyed
pairing into latency rows -> per-probe tables -> latency statistics,
exemplar rows, top keys and counts; plus probe lifecycle replay from a
control log and catalogue queries.  See ``README.md``.
"""

from .specs import PROBES, RAW_SCHEMA, SPECS, TraceSpec, spec  # noqa: F401

__version__ = "0.1.0"
