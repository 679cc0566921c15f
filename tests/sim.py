"""Sequential reference simulations used by the tests (plain Python, one
event at a time, the way the probes and the controller process them)."""

from __future__ import annotations

MASK32 = 0xFFFFFFFF
TWO_64 = 1 << 64


# --- file-name wildcard ------------------------------------------------------

def c_wildcard(pattern: bytes, name: bytes) -> bool:
    """The file rule on bytes, stated directly: the setting is a 16-byte
    buffer (cut at its first NUL), the name at most 15 bytes; a leading
    ``*`` asks for a literal suffix, otherwise lengths must be equal and
    each pattern byte is either ``?`` or the same byte."""
    pat = pattern[:16].split(b"\0", 1)[0]
    nm = name[:15].split(b"\0", 1)[0]
    if pat.startswith(b"*"):
        return nm.endswith(pat[1:])
    return len(pat) == len(nm) and all(p == ord("?") or p == c for p, c in zip(pat, nm))


# --- entry/exit pairing ------------------------------------------------------

def _cut(s, n):
    if s is None:
        return None
    b = s.split("\0", 1)[0].encode()[:n]
    return b.decode("utf-8", "ignore")


def _ntohl(x):
    x &= MASK32
    return ((x & 0xFF) << 24) | (((x >> 8) & 0xFF) << 16) | (((x >> 16) & 0xFF) << 8) | ((x >> 24) & 0xFF)


def simulate_pairing(events, spec, params=None, effect="reference"):
    """``events``: dicts with the raw attributes; returns the table rows."""
    params = params or {}
    comm_cap = min(spec.comm_len - 1, 15)

    def pid_ok(e):
        v = params.get("filter_pid")
        if not v:
            return True
        # only the nfsd probes compare the packed id; all others the process id
        target = e["pid_tgid"] if spec.probe.startswith("nfsd4_") else (e["pid_tgid"] >> 32)
        return target == v

    def comm_ok(e):
        v = params.get("filter_comm")
        if not v:
            return True
        return _cut(e["comm"], comm_cap) == v.encode()[:spec.comm_len].decode("utf-8", "ignore")

    def sys_ok(e):
        v = params.get("filter_syscall_id")
        if not v or (v & MASK32) == 0:
            return True
        return (e["syscall_id"] & MASK32) == (v & MASK32)

    def file_ok(e):
        v = params.get("filter_file")
        if not v:
            return True
        name = _cut(e["file"], spec.file_len - 1) or ""
        if spec.file_match == "wildcard":
            return c_wildcard(v.encode(), name.encode())
        return name == v.encode()[:spec.file_len].decode("utf-8", "ignore")

    checks = {"filter_pid": pid_ok, "filter_comm": comm_ok, "filter_syscall_id": sys_ok,
              "filter_file": file_ok}
    entry_f = [checks[n] for n, w in spec.filters.items() if w in ("entry", "both") and n in params]
    exit_f = [checks[n] for n, w in spec.filters.items() if w == "both" and n in params]
    post_f = [checks[n] for n, w in spec.filters.items() if w == "exit_post" and n in params]
    if effect == "strict" and spec.orphan == "zero":
        post_f += [checks[n] for n, w in spec.filters.items() if w == "entry" and n in params]

    pending = {}
    rows = []
    for e in sorted(events, key=lambda r: (r["ts_ns"], r["seq"])):
        key = tuple(e[k] for k in spec.key_cols)
        if e["kind"] == "entry":
            if all(f(e) for f in entry_f):
                pending[key] = (e["ts_ns"], e["pid_tgid"])
            continue
        if not all(f(e) for f in exit_f):
            continue
        start = pending.pop(key, None)
        if start is None and spec.orphan == "drop":
            continue
        if not all(f(e) for f in post_f):
            continue
        lat = e["ts_ns"] - start[0] if start else 0
        st = start[0] if start else 0
        if spec.pid_mode == "packed":
            pid = e["pid_tgid"]
        elif spec.pid_from == "entry":
            pid = start[1] >> 32
        else:
            pid = e["pid_tgid"] >> 32
        ret = e["ret"]
        v = {
            "pid": pid, spec.latency_col: lat, "time_stamp": e["ts_ns"], "start_timestamp": st,
            "enter_time_stamp": st,
            "size": (ret + TWO_64 if ret < 0 else ret) if spec.probe.startswith("nfs_file")
            else (e["size"] or 0) & MASK32,
            "offset": (e["offset"] or 0) + (TWO_64 if (e["offset"] or 0) < 0 else 0),
            "xid": _ntohl(e["xid"] or 0) if spec.xid_swap else (e["xid"] or 0) & MASK32,
            "comm": _cut(e["comm"], comm_cap),
            "file": _cut(e["file"], spec.file_len - 1) or "",
            "ret": ret, "status": ((ret + (1 << 31)) % (1 << 32)) - (1 << 31),
            "syscall_id": e["syscall_id"] & MASK32,
            "proc_name": _cut(e["proc_name"], 15) or "",
        }
        rows.append(tuple(v[n] for n in spec.names))
    return rows


# --- control log -------------------------------------------------------------

def simulate_control(cmds, implemented, described):
    """Sequential controller: returns {seq: (code, state, last_error, attached_before)}."""
    attached = {}
    status = {}
    out = {}
    for c in sorted(cmds, key=lambda r: r["seq"]):
        p, op, ok, dry = c["probe"], c["op"], c["outcome"] == "ok", c["dry_run"] and c["op"] == "update"
        known = p in implemented or p in described
        att = attached.get(p, False)
        code = None
        if dry:
            code = None
        elif op == "load":
            if att:
                code = "PROBE_ALREADY_LOADED"
            elif p not in implemented:
                code = "PROBE_NOT_FOUND"
            elif ok:
                attached[p] = True
                status[p] = ("loaded", None)
            else:
                code = "PROBE_START_FAILED"
                status[p] = ("error", code)
        elif op in ("unload", "update"):
            if not att:
                code = "PROBE_NOT_LOADED" if known else "PROBE_NOT_FOUND"
            elif op == "unload":
                if ok:
                    attached[p] = False
                    status[p] = ("unloaded", None)
                else:
                    code = "PROBE_STOP_FAILED"
                    status[p] = ("error", code)
            else:
                if ok:
                    status[p] = ("loaded", None)
                else:
                    code = "PROBE_UPDATE_FAILED"
                    status[p] = ("error", code)
        elif op == "status":
            code = None if known else "PROBE_NOT_FOUND"
        st, err = status.get(p, ("unloaded", None)) if known else (None, None)
        out[c["seq"]] = (code, st, err, att)
    return out
