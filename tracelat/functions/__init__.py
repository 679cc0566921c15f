from .scalars import (as_s64, as_u64, byte_cap, cstr, fixed_bytes, json_report, latency,  # noqa: F401
                      ntohl, outcome, pid_of, round3, tid_of, to_fixed_string, to_u32,
                      to_uint64)
from .wildcard import pattern_regex, wildcard_match  # noqa: F401
