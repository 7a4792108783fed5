"""Plain loops over one session at a time: what the window jobs must reproduce."""

import hashlib


def h(text, n=64):
    return hashlib.sha256(text.encode()).hexdigest()[:n]


def units_a(records):
    """Units of a family-A log without side conversation: dicts of q, answer, tokens, order."""
    units, cur = [], None

    def open_unit(rec, text):
        nonlocal cur
        cur = dict(uuid=rec["uuid"], parent=rec.get("parentUuid") or "", ts=rec["timestamp"],
                   users=[(rec["uuid"], text)], progress=[], final=None)
        units.append(cur)

    for rec in records:
        kind = rec["type"]
        if kind == "attachment":
            text = rec["attachment"]["prompt"]
            if cur is None or cur["final"]:
                open_unit(rec, text)
            else:
                cur["users"].append((rec["uuid"], text))
        elif kind == "user":
            content = rec["message"]["content"]
            if rec.get("isMeta"):
                noise = content.lstrip().startswith("<system-reminder>")
                known = [u for u, _ in cur["users"]] if cur else []
                if cur and not cur["final"] and not noise and rec.get("parentUuid") in known:
                    cur["users"].append((rec["uuid"], content))
            elif isinstance(content, list):
                if cur:
                    cur["progress"].append(rec)
            else:
                retyped = cur and rec.get("parentUuid") and rec["parentUuid"] == cur["parent"]
                if cur is None or cur["final"] or retyped:
                    open_unit(rec, content)
                else:
                    cur["users"].append((rec["uuid"], content))
        elif kind == "assistant" and cur:
            if cur["final"]:
                cur["progress"].append(cur["final"])
            cur["final"] = rec
    out = []
    for u in units:
        asst = [p for p in u["progress"] if p["type"] == "assistant"]
        asst += [u["final"]] if u["final"] else []
        said = [a["message"]["content"] for a in asst if a["message"]["content"]]
        usage = [a["message"]["usage"]["input_tokens"] for a in asst if "usage" in a["message"]]
        models = [a["message"]["model"] for a in asst if a["message"].get("model")]
        out.append(dict(
            q_uuid=u["uuid"],
            question="\n\n".join(t.rstrip() for _, t in u["users"] if t.rstrip()),
            answer=said[-1] if said else "",
            tok_in=sum(usage) if usage else None,
            model=models[-1] if models else "",
            progress_count=len(u["progress"]),
            fork_keys=[k for k, _ in u["users"]] + ([u["final"]["uuid"]] if u["final"] else []),
        ))
    return out


class RolloutB:
    """One family-B file, record by record."""

    def __init__(self):
        self.entries, self.pending = [], []
        self.turn = self.cwd = self.session_cwd = self.version = self.model = ""
        self.asked = self.sub = self.seen_meta = self.marker = False
        self.waiting, self.ids_here, self.item_ids, self.turn_n = [], set(), {}, {}
        self.prev_total = None
        self.session = ""

    def add(self, cls, **kw):
        e = dict(cls=cls, uuid=f"{cls}-{len(self.entries)}", turn=self.turn,
                 cwd=self.cwd or self.session_cwd, model=self.model, usage=None, text="",
                 only=False, kind="X", key=None)
        e.update(kw)
        self.entries.append(e)
        return e

    def user(self, text, ts, kind="U", turn=None, msg=None):
        turn = turn or self.turn
        e = self.add("u", text=text, ts=ts, kind=kind, turn=turn, msg=msg, tkey=None)
        if turn:
            n = self.turn_n.get(turn, 0)
            self.turn_n[turn] = n + 1
            e["tkey"] = f"{turn}#{n}"

    def flush(self):
        if not self.asked and self.waiting:
            for text, ts in self.waiting:
                self.user(text, ts)
            self.asked = True
        self.waiting = []

    def latest(self, with_text):
        for e in reversed(self.entries):
            if e["cls"] == "a" and e["turn"] == self.turn and (e["text"] or not with_text):
                return e
        return None

    def credit(self, info):
        total, last = info.get("total_token_usage"), info.get("last_token_usage")
        prev = self.prev_total
        if total is None:
            use = last
        elif prev is None:
            use = last if self.sub else total
        elif any(k in total and k in prev and total[k] < prev[k] for k in total):
            use = last if last is not None else total
        else:
            use = {k: max(0, total.get(k, 0) - prev.get(k, 0)) for k in total}
            use = use if any(use.values()) else None
        if total is not None:
            self.prev_total = total
        if use:
            e = self.latest(False)
            if e is not None and e["usage"] is None:
                e["usage"] = use
            else:
                self.add("a", only=True, usage=use)

    def feed(self, rec):
        p, ts, outer = rec["payload"], rec["timestamp"], rec["type"]
        after, self.marker = self.marker, outer == "inter_agent_communication_metadata"
        part = p.get("type", "")
        if outer == "session_meta":
            first, self.seen_meta = not self.seen_meta, True
            if first:
                self.sub = p.get("thread_source") == "subagent"
            if not first and self.sub:
                return
            self.session = (p["id"] if self.sub else p["session_id"]) or self.session
            self.session_cwd = p.get("cwd") or self.session_cwd
            self.cwd = self.session_cwd
        elif outer == "turn_context":
            self.turn = p.get("turn_id") or self.turn
            self.cwd = p.get("cwd") or self.cwd
            self.model = p.get("model") or self.model
        elif outer == "event_msg" and part == "task_started":
            self.flush()
            self.turn = p.get("turn_id") or self.turn
            self.asked, self.waiting = False, []
            self.ids_here.clear()
        elif outer == "event_msg" and part == "user_message":
            if p["message"]:
                self.user(p["message"], ts)
            self.asked = True
        elif outer == "event_msg" and part == "agent_message":
            self.flush()
            if p["message"]:
                self.add("a", text=p["message"])
        elif outer == "event_msg" and part == "token_count":
            self.credit(p["info"])
        elif outer == "event_msg" and part == "task_complete":
            self.flush()
            said = self.latest(True)
            answer = p.get("last_agent_message") or ""
            if answer and answer != (said["text"] if said else ""):
                self.add("a", text=answer)
        elif outer == "response_item":
            self.item(p, part, ts, after)

    def item(self, p, part, ts, after):
        text = "\n".join(b["text"] for b in p.get("content", []) if b.get("text"))
        if after and part == "agent_message":
            self.flush()
            if text:
                up = p["author"].startswith(p["recipient"] + "/")
                self.user(text, ts, "D" if up else "R", p.get("own_turn"), p.get("id"))
        elif part == "message" and p["role"] == "user":
            if text and not text.startswith("<system-"):
                mid = p.get("id", "")
                if mid not in self.ids_here or not mid:
                    self.waiting.append((text, ts))
                    if mid:
                        self.ids_here.add(mid)
                        self.item_ids.setdefault(self.turn, []).append([text, mid, False])
        elif part == "reasoning":
            self.flush()
            body = "\n".join(s["text"] for s in p["summary"])
            if body:
                self.add("a", only=True, key=f"reasoning#{p['id']}~{h(body, 12)}")
        elif part == "function_call":
            self.flush()
            self.add("a", only=True, key="call")
        elif part == "function_call_output":
            self.add("r", key=f"result#{p['call_id']}~{h(p['output'], 12)}")

    def units(self):
        self.flush()
        for e in self.entries:
            if e["cls"] == "u" and not e["msg"]:
                for slot in self.item_ids.get(e["turn"], []):
                    if slot[0] == e["text"] and not slot[2]:
                        slot[2], e["msg"] = True, slot[1]
                        break
        out, cur = [], None
        for e in self.entries:
            if e["cls"] == "u" and not (e["kind"] == "D" and cur):
                if cur is None or e["kind"] == "R" or cur["final"] or cur["progress"]:
                    cur = dict(users=[e], progress=[], final=None)
                    out.append(cur)
                else:
                    cur["users"].append(e)
            elif cur and (e["cls"] != "a" or e["only"]):
                cur["progress"].append(e)
            elif cur:
                if cur["final"]:
                    cur["progress"].append(cur["final"])
                cur["final"] = e
        res = []
        for u in out:
            asst = [e for e in u["progress"] + [u["final"]] if e and e["cls"] == "a"]
            said = [e["text"] for e in asst if not e["only"] and e["text"]]
            use = [e["usage"] for e in asst if e["usage"]]
            parts = [f"m:{e['msg']}" if e["msg"] else (f"t:{e['tkey']}" if e["tkey"] else "")
                     for e in u["users"]]
            anchors = u["users"] + ([u["final"]] if u["final"] else []) + u["progress"]
            res.append(dict(
                q_uuid=u["users"][0]["uuid"], ts_raw=u["users"][0]["ts"],
                question="\n\n".join(e["text"] for e in u["users"]),
                answer=said[-1] if said else "",
                tok_in=sum(x.get("input_tokens", 0) for x in use) if use else None,
                model=next((e["model"] for e in reversed(asst) if e["model"]), ""),
                cwd=next((e["cwd"] for e in anchors if e["cwd"]), ""),
                progress_count=len(u["progress"]),
                replay_key=h("\0".join(parts)) if all(parts) else "",
            ))
        return res
