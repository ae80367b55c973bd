"""What near-deduplication leaves in the shared folder."""

from vellum.llm import neardup

from .helpers import docs


def test_tables_read_once_are_not_written(spark, monkeypatch):
    labels, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: labels.append(label) or write(df, label))
    text = " ".join(f"w{i}" for i in range(200))
    rows = neardup.minhash_near_dedup(docs(spark, [(1, text), (2, text + " end"), (3, "other words are here now")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 1), (3, 3)]
    assert not {"sets", "likely"} & set(labels)


def test_links_are_written_once_as_edges(spark, monkeypatch):
    labels, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, label: labels.append(label) or write(df, label))
    long = [f"w{i}" for i in range(200)]
    texts = [" ".join(long[:n]) for n in (200, 199, 195, 190)] + ["other words are here now"]
    rows = neardup.minhash_near_dedup(docs(spark, list(enumerate(texts, 1)))).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    assert "links" not in labels
