import hashlib
import random

from pyspark.sql import functions as F

from ratiolake.llm import chat_format as cf

EVENTS = "conv_id bigint, turn bigint, part bigint, seq bigint, kind string, role string, text string"
NASTY = ["</s>", "<s>", "[INST] ok [/INST]", "<\\/s>", "<\\\\/s>", "<<SYS>>x<</SYS>>", "<|im_end|>", "<|\n|>", "a\\", "%0A%25", "", "é\U0001f600</s", "s>", "<", "[", "\\<s>", "<s></s>\n"]


def fold(events):
    out = {}
    for e in sorted(events, key=lambda e: (e[3] is not None, e[3] or 0, e[4] or "delta", e[5] or "", e[6] or "")):
        key = e[:3]
        kind, text = e[4] or "delta", e[6] or ""
        m = out.setdefault(key, {"role": "", "text": "", "gone": False})
        m["role"] = e[5] or m["role"]
        if kind == "delete":
            m.update(text="", gone=True)
        elif kind in ("edit", "regenerate"):
            m.update(text=text, gone=False)
        else:
            m.update(text=m["text"] + text, gone=False)
    return {k: (m["role"], m["text"]) for k, m in out.items() if not m["gone"]}


def test_fold_render_and_read_back(spark):
    random.seed(13)
    events = []
    for conv in [*range(12), None]:
        for turn in range(random.randint(1, 5)):
            for seq in range(random.randint(1, 6)):
                events.append((conv, turn, random.choice([0, 1, None]), random.choice([seq, seq, None]), random.choice(["delta", "delta", None, "edit", "regenerate", "delete"]), random.choice(["user", "assistant", None, "we%ird\n<s>", ""]), random.choice([None, *NASTY])))
    log = spark.createDataFrame(events, EVENTS).withColumns({c: F.lit(1) for c in ("log", "at", "segment", "head")}).repartition(3)
    messages = cf.fold_events(log)
    want = fold(events)
    assert {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in messages.collect()} == want
    rendered = cf.render(messages)
    back = {}
    for r in sorted(cf.turns_back(rendered).collect(), key=lambda r: r.at):
        back.setdefault(r.conv_id, []).append(r)
    told = {r.conv_id: r for r in cf.digests(rendered).collect()}
    out = rendered.collect()
    by_conv = {}
    first = lambda x: (x is not None, x or 0)
    for (c, t, p), m in sorted(want.items(), key=lambda x: (first(x[0][1]), first(x[0][2]))):
        by_conv.setdefault(c, []).append(m)
    assert {c: [(t.role, t.text) for t in turns] for c, turns in back.items()} == by_conv
    assert len(told) == len(out) == len(by_conv)
    for r in out:
        assert r.n_turns == len(by_conv[r.conv_id])
        loss = "".join(t for role, t in by_conv[r.conv_id] if role == "assistant")
        assert "".join(t.learned for t in back[r.conv_id] if t.learned is not None) == loss
        d = told[r.conv_id]
        whole = "".join(f"{role}\n{t}\n" for role, t in by_conv[r.conv_id])
        assert tuple(d)[1:] == (r.n_turns, hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r.formatted))
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.n_turns and "[INST]" not in r.formatted


def test_rows_that_share_a_turn_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", None), (1, None, None, "n"), (1, 1, "assistant", "later")], "conv_id bigint, turn bigint, role string, text string")
    log = cf.turns_as_events(rows)
    assert {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"}
    out = cf.turns_back(cf.render(cf.fold_events(log))).orderBy("at").collect()
    # a null role is empty, a null turn comes first
    assert [(t.role, t.text, t.learned) for t in out] == [("", "n", None), ("assistant", "", ""), ("user", "a", None), ("user", "a", None), ("assistant", "later", "later")]
    assert cf.render(cf.fold_events(cf.turns_as_events(rows.limit(0)))).collect() == []
