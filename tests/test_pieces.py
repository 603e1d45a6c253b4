"""Long sequences in pieces: everything that crosses an edge, against whole sequences."""

import random

import pytest
from pyspark.sql import functions as F
from strandframe.functions import dna
from strandframe.functions.frames import all_frames
from strandframe.operators import ordered, pieces, scan
from strandframe.sources import formats


def genome(seed=1):
    rng = random.Random(seed)
    out = {"long": "".join(rng.choice("ACGT") for _ in range(4000)), "open": "ATG" + "GCC" * 300, "none": "TAA" * 100, "unknown": "ATGNNN" * 80 + "TAG", "a": "A", "ab": "AT", "": "ACGTTT"}
    out["sites"] = "".join(rng.choice(["GAATTC", "AAGCTT", "GGATCC", "AC", "GAATTCGAATTC"]) for _ in range(120))
    return out


def codon_frames(seq, min_aa):
    """Frames by walking codons: from the first ATG after a stop to the next stop."""
    back = seq.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    out = []
    for strand, text in (("+", seq), ("-", back)):
        for frame in range(3):
            start = None
            places = list(range(frame, len(text) - 2, 3))
            for i in places:
                codon = text[i : i + 3]
                if codon in dna.STOPS:
                    if start is not None:
                        out.append((strand, frame + 1, start, i, True, text[start:i]))
                    start = None
                elif codon == "ATG" and start is None:
                    start = i
            if start is not None:
                out.append((strand, frame + 1, start, len(text), False, text[start : start + (len(text) - start) // 3 * 3]))
    rows = []
    for strand, frame, a, b, stop, letters in out:
        protein = "".join(dna.CODONS.get(letters[i : i + 3], "X") for i in range(0, len(letters), 3))
        if len(protein) >= min_aa:
            low, high = (len(seq) - b, len(seq) - a) if strand == "-" else (a, b)
            rows.append((strand, frame, low, high, len(protein), protein, stop))
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, v) for k, v in genome().items()], "seq_id string, seq string").cache()


@pytest.mark.parametrize(("size", "min_aa", "tile"), [(6144, 30, 4096), (30, 1, 2), (33, 12, 4096), (96, 30, 3)])
def test_frames_over_edges(spark, table, monkeypatch, size, min_aa, tile):
    monkeypatch.setattr(pieces, "_TILE", tile)
    got = pieces.orfs(pieces.cut(table, ahead=2, size=size), min_aa, reverse=True).collect()
    want = sorted((k, *r) for k, v in genome().items() for r in codon_frames(v, min_aa))
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("size", [6, 300])
def test_translation_and_codons_over_edges(spark, table, size):
    cut = pieces.cut(table, ahead=2, size=size)
    parts = {}
    for r in sorted(pieces.translated(cut).collect(), key=lambda r: r.order):
        parts[r.seq_id, r.frame] = parts.get((r.seq_id, r.frame), "") + r.protein
    whole = table.select("seq_id", *[dna.translate("seq", f).alias(str(f)) for f in (1, 2, 3, -1, -2, -3)], all_frames("seq").alias("all")).collect()
    for r in whole:
        for i, f in enumerate((1, 2, 3, -1, -2, -3)):
            assert parts.get((r.seq_id, f), "") == r[str(f)] == r["all"][i]
    for f in (2, -3):
        rows = pieces.codons(cut, ["seq_id"], f).groupBy("seq_id", "codon").count()
        want = table.select("seq_id", F.explode(dna.codons("seq", f)).alias("codon")).groupBy("seq_id", "codon").count()
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("circular", [True, False])
@pytest.mark.parametrize("size", [7, 1024])
def test_sites_and_fragments_over_edges(spark, table, monkeypatch, circular, size):
    monkeypatch.setattr(scan, "SITE_PIECE", size)
    monkeypatch.setattr(ordered, "POSITION_TILE", 16)
    names = ["EcoRI", "BamHI", "HindIII"]
    got = sorted((r.seq_id, r.start, r.end, r["size"]) for r in scan.digest(table, names, circular).collect())
    want = []
    for k, seq in genome().items():
        cuts = sorted({i + cut for _, _, site, cut, _ in scan.site_table(names, False) for i in range(len(seq)) if seq.startswith(site, i)})
        if circular:
            pairs = [(a, b) for a, b in zip(cuts, cuts[1:] + cuts[:1])] or [(0, len(seq))]
        else:
            pairs = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(seq)]) if b > a]
        want += [(k, a, b, b - a if b > a else len(seq) - a + b) for a, b in pairs]
    assert got == sorted(want)


def test_fasta_lines_to_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "LINE_TILE", 7)
    seqs = {f"s{i} of test": v for i, v in enumerate(genome().values())}
    text = "".join(f">{k}\n" + "\n".join(v[i : i + 11] for i in range(0, len(v), 11)) + "\n" for k, v in seqs.items())
    (tmp_path / "a.fa").write_text("lost letters\n" + text + ">empty\n>again\r\nACGT acgt\r\n")
    (tmp_path / "b.fa").write_text("ACGTNOHEAD\n\n>again\n" + "G" * 100 + "\n>last\nTTT")
    rows = formats.read_fasta_pieces(spark, str(tmp_path), 30, first_token=True).collect()
    whole, names = {}, {}
    for r in sorted(rows, key=lambda r: (r.record, r.piece)):
        assert r.offset == r.piece * 30 == len(whole.get(r.record, "")) and r["size"] == len(r.text) <= 30
        whole[r.record] = whole.get(r.record, "") + r.text
        names[r.record] = (r.seq_id, r.seq_len)
    want = [(f"s{i}", v) for i, v in enumerate(genome().values())] + [("again", "ACGTacgt"), ("again", "G" * 100), ("last", "TTT")]
    assert [(names[k][0], v) for k, v in sorted(whole.items())] == want
    assert all(names[k][1] == len(v) for k, v in whole.items())
    ahead = pieces.with_ahead(formats.read_fasta_pieces(spark, str(tmp_path), 30), "record", 5).collect()
    for r in ahead:
        assert r.text == whole[r.record][r.offset : r.offset + r["size"] + 5] and r.seq_len == len(whole[r.record])
