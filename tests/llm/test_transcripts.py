import random

import numpy as np
import pytest

from docquarry.llm import transcripts as T

SAID = ["The budget draft is on page two.", "Nobody could say who wrote it.", "uh... (applause)", "Please file the ledger by Friday.", "What remains open is the roster."]
WHO = ["Anna Berg", "Teo Marnik", "Teo Marnik", "T. Marnik", "BERG, ANNA"]
WANT = ["anna berg", "teo marnik", "anna berg"]


def clock(i):
    return f"00:00:{10 * i + 3:02d}"


FORMATS = {
    "bracket": lambda: "\n".join(f"[{clock(i)}] {w} : {s}" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "paren": lambda: "\n".join(f"{w} ({10 * i}.5s): {s}" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "plain": lambda: "Meeting record Berg\nParticipants: Anna Berg, Teo Marnik\nDate: 2024-01-02\n\n" + "\n".join(f"{w}: {s}" for w, s in zip(WHO, SAID)),
    "arrows": lambda: "─── audio (90 s) ───\n" + "\n".join(f">> {w}: {s}\n  And so it went on." for w, s in zip(WHO, SAID)),
    "vtt": lambda: "WEBVTT\n\n" + "\n\n".join(f"{clock(i)}.100 --> {clock(i)}.900\n<v {w}>{s}</v>" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "srt": lambda: "\r\n\r\n".join(f"{i + 1}\r\n{clock(i)},100 --> {clock(i)},900\r\n{w}: {s}" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "block": lambda: "\n\n".join(f"{w}\n{clock(i)}.5\n{s}" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "seconds block": lambda: "\n\n".join(f"{w}\n{10 * i}.5s\n{s}" for i, (w, s) in enumerate(zip(WHO, SAID))),
    "dash": lambda: "\n".join(f"{w} – {s}" for w, s in zip(WHO, SAID)),
}


@pytest.mark.parametrize("name", FORMATS)
def test_formats(name):
    text = FORMATS[name]()
    got = [t[1] for t in T.turns(text)]
    assert got == (WANT if name != "arrows" else ["anna berg", "teo marnik", "anna berg"])


def test_time_order_only_with_all_times():
    late = "[00:30] Anna Berg: second.\n[00:10] Teo Marnik: first.\n[00:40] Anna Berg: third."
    assert [t[1] for t in T.turns(late)] == ["teo marnik", "anna berg"]
    some = late.replace("[00:10] ", "")
    assert [t[1] for t in T.turns(some)] == ["anna berg", "teo marnik", "anna berg"]


def test_labels():
    labels = ["Speaker 1", "SPEAKER_02", "S1", "Spkr. 2", "Chair.", "Chairperson", "Dr. Ines Calmer", "Calmer", "Ines (Host)", "Calmer, Ines", "Ines Calmer, IT", "ines calmer", "I. Calmer", "Ines Calmer [remote]", "Resp."]
    got = T.speaker_names(labels)
    assert [got[x] for x in labels] == ["speaker 1", "speaker 2", "speaker 1", "speaker 2", "chairperson", "chairperson"] + ["ines calmer"] * 8 + ["resp"]


def test_cleaning():
    assert T.cleaned("The — uh — budget budget [door closes] draft, um, is *coughs* here.") == "The budget draft, is here."
    assert not T.spoken("uh... (applause) ♪ la ♪ you know, [music] <noise>") and T.spoken("uh yes")


@pytest.mark.parametrize("text", [None, "", "no transcript: at all", "- the floor plan: 3\n- the ledger: 4\n- das Fotoalbum: 5\n- das Fotoalbum: 6", "Note: something\nTime: 9:30\nOwner: Calford", "Subject: x\nDate: 3 May 2020\n\nText follows."])
def test_other_texts_have_no_turns(text):
    assert T.turns(text) == []


def test_training_and_held_out():
    texts = [f() for f in FORMATS.values()] * 3
    model = T.train(texts)
    for text in texts[:9]:
        lines = T.parse(text)
        assert T.segment(lines, model) == T.weak_labels(lines)
    assert T.train([]) == T.Model()


def generated(seed):
    """A transcript of three speakers in one of the formats with marks."""
    rng = random.Random(seed)
    words = "budget draft page ledger friday roster garden museum letter contract office survey plan archive".split()
    at, out, style = 0, [], rng.choice(["bracket", "paren", "arrows", "block", "plain"])
    for i in range(rng.randint(8, 20)):
        who = rng.choice(["Anna Berg", "Teo Marnik", "Ines Calmer"])
        topic = rng.sample(words, 3)
        said = [f"The {' and the '.join(rng.sample(topic, 2))} {rng.choice(['are open', 'came late', 'were read'])}{rng.choice('..?')}" for _ in range(rng.randint(1, 3))]
        at += rng.randint(3, 20)
        mark = f"{at // 60:02d}:{at % 60:02d}"
        head = {"bracket": f"[{mark}] {who}: ", "paren": f"{who} ({mark}): ", "arrows": f">> {who}: ", "block": f"{who}\n{mark}\n", "plain": f"{who}: "}[style]
        out.append(head + "\n".join(said))
    return "\n".join(out)


def starts(division):
    return {i for i, _, turn in division if turn}


def test_model_finds_turns_that_marks_do_not_show():
    """Times, marks and the looks of labels are hidden on part of the lines of held-out transcripts."""
    model = T.train([generated(i) for i in range(120)])
    rng, scores = random.Random(5), {"rule": [], "model": []}
    for i in range(1000, 1080):
        lines = T.parse(generated(i))
        gold, seen = starts(T.weak_labels(lines)), T.hidden(lines, rng)
        for name, got in (("rule", starts(T.weak_labels(seen))), ("model", starts(T.segment(seen, model)))):
            scores[name].append(2 * len(got & gold) / (len(got) + len(gold)))
    rule, learned = (sum(x) / len(x) for x in scores.values())
    assert learned > 0.97 and learned > rule + 0.04


def test_likelihood_has_the_right_gradient():
    rng = random.Random(2)
    data = [(T.hidden(lines, rng), T.weak_labels(lines)) for lines in (T.parse(generated(i)) for i in range(6))]
    parts, w = T._padded(data), T.Model().flat() * 0.3
    _, gradient = T._likelihood(w, *parts)
    for i in range(len(w)):
        e = np.zeros(len(w))
        e[i] = 1e-5
        assert (T._likelihood(w + e, *parts)[0] - T._likelihood(w - e, *parts)[0]) / 2e-5 == pytest.approx(gradient[i], abs=1e-3)


def test_best_division_beats_all_others():
    """Against all divisions of few lines, scored one by one."""
    model = T.Model()
    lines = T.hidden(T.parse(generated(4))[:6], random.Random(1))
    begin, on, out = (f @ np.array(w) for f, w in zip(T.features(lines), (model.start, model.inside, model.rest)))

    def divisions(i):
        if i == len(lines):
            yield []
        for rest in divisions(i + 1) if i < len(lines) else ():
            yield [(i, i + 1, False), *rest]
        for j in range(i + 1, len(lines) + 1):
            for rest in divisions(j):
                yield [(i, j, True), *rest]

    def score(d):
        return sum(begin[i] + sum(on[q] + model.length[min(q - i, 3) - 1] for q in range(i + 1, j)) if turn else out[i] for i, j, turn in d)

    assert score(T.segment(lines, model)) == pytest.approx(max(map(score, divisions(0))))


def test_recurring_plain_labels_and_labels_that_are_none():
    text = "Anna Berg: The plan.\nthe tall visitor in grey: The ledger.\nAnna Berg: Bring these,\nSecond: the ledger,\nand the roster.\nthe tall visitor in grey: Yes."
    got = T.turns(text)
    assert [t[1] for t in got][:2] == ["anna berg", "the tall visitor in grey"] and [t[1] for t in got][-1] == "the tall visitor in grey"


def test_long_text_is_read_whole():
    text = "\n".join(f"[{i // 60:02d}:{i % 60:02d}] Speaker {i % 2 + 1}: item number {i}" for i in range(2000))
    assert len(T.turns(text)) == 2000


def test_frame(spark):
    rows = [(k, f(), 1) for k, f in FORMATS.items()] + [("null", None, 1), ("empty", "", 1), ("bracket", FORMATS["bracket"](), 1)]
    df = spark.createDataFrame(rows, "id string, t string, turn_no int")
    got = T.speaker_turns(df, "id", "t").distinct().collect()
    assert {r["id"] for r in got} == set(FORMATS) and len(got) == 3 * len(FORMATS)
    assert T.speaker_turns(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("shape", ["{w}:\n{s}", "{w}:\t{s}", "{w}:\r\n{s}", "{w}:\xa0{s}", "{pad}{w}:\n{s}", "{w} –\t{s}", "{w} ({t}):\n{s}"])
def test_separators_of_the_parser_pass_the_filter(spark, shape):
    text = "\n".join(shape.format(w=w, s=s, pad=" " * 50, t=clock(i)) for i, (w, s) in enumerate(zip(WHO, SAID)))
    want = [t[1] for t in T.turns(text)]
    df = spark.createDataFrame([("a", text)], "id string, t string")
    got = [r["speaker"] for r in T.speaker_turns(df, "id", "t", T.Model()).orderBy("turn_no").collect()]
    assert got == want == WANT
