"""A small sequential interpreter of the detection semantics, for comparison on random captures.

It covers the detectors the random captures exercise and keeps plain dictionaries; it shares nothing
with the plans under test.
"""

from __future__ import annotations

import math

FAMILY = {"sensitive_write": "watched_write", "persistence_write": "watched_write",
          "ptrace_attach": "process_access", "cross_uid_proc_read": "process_access"}
DAEMONS = ["nginx", "node", "postgres"]
ROOTS = ["nginx", "sshd", "postgres", "node"]
SHELLS = ["sh", "bash"]
INTERPRETERS = ["node"]


class Node:
    def __init__(self):
        self.parent, self.comm, self.exe, self.trusted, self.container = None, "", "", "", ""


class Interpreter:
    def __init__(self, floor=0, baseline=None, rules=()):
        self.nodes, self.bucket, self.reported = {}, {}, {}
        self.floor, self.baseline, self.rules = floor, baseline, list(rules)
        self.partial = {}

    def ancestry(self, key):
        out = []
        while key is not None and key in self.nodes and key not in out:
            out.append(key)
            key = self.nodes[key].parent
        return out

    def node(self, key):
        return self.nodes.setdefault(key, Node())

    def apply(self, e):
        key = (e["tgid"], e["start_boottime"])
        if e["type"] == 3:
            p = self.node(key)
            p.comm = p.comm or e["comm"]
            c = self.node((e["child_pid"], e["child_start_boottime"]))
            c.parent = key
            c.container = e["container"] or c.container
            c.comm = c.comm or e["comm"]
        elif e["type"] == 1:
            n = self.node(key)
            n.comm, n.exe, n.trusted = e["comm"], e["filename"], e["exe_trusted"]
            n.container = e["container"] or n.container
        elif e["type"] == 4:
            n = self.node(key)
            n.comm = n.comm or e["comm"]
            n.container = e["container"] or n.container

    def detect(self, e):
        key, t, f = (e["tgid"], e["start_boottime"]), e["type"], e["filename"]
        n = self.nodes.get(key, Node())
        chain = self.ancestry(key)
        if t == 6:
            return [("suid_create", 45, key)]
        if t == 4 and e["uid"] != 0 and e["old_euid"] != 0 and e["euid"] == 0:
            return [("privilege_escalation", 40, key)]
        if t == 8:
            if e["aux"] & 2:
                return [("ptrace_attach", 30, key)]
            if not any(k[0] == e["target_pid"] for k in chain):
                return [("cross_uid_proc_read", 25, key)]
        if t == 5:
            if e["file_mode"] & 2:
                if "core_pattern" in f:
                    return [("kernel_escape_hatch_write", 75 if e["container"] else 45, key)]
                if "/etc/cron" in f:
                    return [("persistence_write", 30, key)]
                return [("sensitive_write", 20, key)]
            if n.trusted not in ("sudo", "sshd"):
                return [("credential_store_read", 30, key)]
        if t == 10:
            kernel = any(
                self.nodes[k].comm == "kthreadd" or self.nodes[k].comm.startswith("kworker/")
                for k in chain
            )
            return [("module_autoload", 10, key) if kernel else ("module_load", 50, key)]
        if t == 12 and n.trusted not in DAEMONS:
            return [("unexpected_listener", 25, key)]
        if t == 1:
            out = []
            if f.startswith("/tmp/"):
                out.append(("exec_from_tmp", 20, key))
            base = f.split("/")[-1]
            if base in SHELLS or base in INTERPRETERS:
                for k in chain:
                    m = self.nodes[k]
                    if m.trusted in DAEMONS or any(m.comm.startswith(d) for d in DAEMONS):
                        shell = ("shell_from_network_daemon", 50, key)
                        other = ("interpreter_from_network_daemon", 25, key)
                        out.append(shell if base in SHELLS else other)
                        break
            return out
        return []

    def run_rules(self, e):
        """Rules are (id, score, scope, within, steps) with steps as predicates on the event."""
        out = []
        own = (e["tgid"], e["start_boottime"])
        for idx, (id_, sc, scope, within, steps) in enumerate(self.rules):
            key = own
            if scope == "same_lineage":
                chain = self.ancestry(own)
                key = chain[-1] if chain else own
            p = self.partial.get((idx, key))
            if p and max(e["ts_ns"] - p[1], 0) > within:
                del self.partial[(idx, key)]
                p = None
            if p and steps[p[0]](e):
                p = (p[0] + 1, p[1])
                if p[0] == len(steps):
                    del self.partial[(idx, key)]
                    out.append((id_, sc, key))
                else:
                    self.partial[(idx, key)] = p
                continue
            if steps[0](e):
                if len(steps) == 1:
                    out.append((id_, sc, key))
                else:
                    self.partial[(idx, key)] = (1, e["ts_ns"])
        return out

    def step(self, e):
        self.apply(e)
        new = self.detect(e) + self.run_rules(e)
        if not new:
            return None
        subject = new[0][2]
        b = self.bucket.setdefault(subject, {})
        for id_, sc, key in new:
            if id_ not in b or b[id_][0] < sc:
                b[id_] = (sc, e["ts_ns"], key)
        chain = self.ancestry(subject) or [subject]
        on_file = [(i, *v) for k in chain for i, v in self.bucket.get(k, {}).items()]
        scored = []
        for i, sc, ts, key in on_file:
            if self.baseline:
                exe = self.nodes[key].exe if key in self.nodes else ""
                f = self.baseline.get((i, exe), 1.0)
                if f < 1.0:
                    sc = math.floor(sc * f + 0.5)
            scored.append((i, sc, ts))
        newest = max(s[2] for s in scored)
        fam = {}
        for i, sc, ts in scored:
            if newest - ts <= 600_000_000_000:
                k = FAMILY.get(i, i)
                fam[k] = max(fam.get(k, 0), sc)
        base, top = sum(fam.values()), max(fam.values())
        chain_bonus = (len(fam) - 1) * top // 2 if len(fam) > 1 else 0
        m = 1.0
        last = self.nodes.get(chain[-1])
        if last and last.comm in ROOTS:
            m *= 1.3
        if any(k in self.nodes and self.nodes[k].container for k in chain):
            m *= 1.1
        total = min(100, math.floor((base + chain_bonus) * m + 0.5))
        rank = sum(total >= b for b in (25, 50, 75, 90))
        if rank < self.floor or rank <= self.reported.get(subject, -1):
            return None
        self.reported[subject] = rank
        return (e["host"], e["seq"], *subject, base, chain_bonus, total, rank)
