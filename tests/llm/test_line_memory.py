"""Workers live on from stage to stage: each step in Python gives back what its task took, those of the doubling and of the texts too."""

import pandas as pd

from papyra.llm import line_dedup


def test_every_step_gives_its_memory_back(spark, monkeypatch):
    run = "One two three four five. Six seven eight nine ten. "
    docs = spark.createDataFrame([(i, run * 6 + f"Text {i} goes on.") for i in range(4)] + [(9, None)], "doc_id long, text string")
    steps, frame = [], type(docs)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **k: steps.append(f) or plain(self, f, *a, **k))
    assert line_dedup.dedup_lines(docs).count() == 5
    given = []
    monkeypatch.setattr(line_dedup, "trimmed", lambda rows, keep="": given.append(rows) or rows)
    for k, step in enumerate(steps, 1):
        step(iter(()))
        assert len(given) == k, f"step {k} of {len(steps)} keeps its memory"
    assert len(steps) >= 10
    left = list(line_dedup._rebuilt(iter([(pd.Series(["Ab. Cd.", None]), pd.Series([[0], None], dtype=object))])))
    assert len(given) == len(steps) + 1 and left[0].tolist() == ["Cd.", None]
