"""Result-record and leaderboard formats of the reference, written by hand."""

import json
import os

from sensorlab.sources import results as RS


def test_result_records_in_reference_styles(spark, tmp_path):
    files = {
        "01/TimesNet/result_classification.txt": "model_id:abc\nseq_len:17\n\n\naccuracy:0.6207\nf1_macro:0.6096\n",
        "17/TimesNet/result_classification.txt": "Accuracy: 0.9422\nF1 Macro: 0.9433\nECE: 0.4819\n",
        "03/SVM/result_classification.txt": "accuracy:0.358\nf1_micro:0.358\n",
        "03/XGB/result_classification.txt": "run a\naccuracy:0.5\nrun b\naccuracy:0.9571\n",
    }
    for rel, text in files.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True)
        p.write_text(text)
    got = {(r["dataset"], r["model"], r["metric"]): r["value"] for r in RS.read_records(spark, str(tmp_path)).collect()}
    assert got[("01", "TimesNet", "accuracy")] == 0.6207
    assert got[("01", "TimesNet", "seq_len")] == 17.0
    assert ("01", "TimesNet", "model_id") not in got
    assert got[("17", "TimesNet", "f1 macro")] == 0.9433
    assert got[("03", "XGB", "accuracy")] == 0.9571          # last one wins


def test_pretty_printed_leaderboard(spark, tmp_path):
    doc = {"01": {"TimesNet": {"timestamp": "2024-01-01 10:00:00", "results": {"accuracy": 0.62, "loss": 1.1}}},
           "02": {"MLP": {"timestamp": "2024-01-02 10:00:00", "results": {"accuracy": 0.26}}}}
    p = os.path.join(tmp_path, "leaderboard.json")
    with open(p, "w") as fh:
        json.dump(doc, fh, indent=2)
    rows = {(r["dataset"], r["model"], r["metric"]): r["value"]
            for r in RS.read_leaderboard(spark, p, multi_line=True).collect()}
    assert rows == {("01", "TimesNet", "accuracy"): 0.62, ("01", "TimesNet", "loss"): 1.1,
                    ("02", "MLP", "accuracy"): 0.26}


def test_sample_archive_of_objects(spark, tmp_path):
    import numpy as np
    import pytest
    from sensorlab.session import ship
    from sensorlab.sources.samples import read_npz
    ship(spark)
    for split, n in (("TRAIN", 3), ("TEST", 2)):
        data = np.empty((n, 2), dtype=object)
        for i in range(n):
            data[i, 0], data[i, 1] = np.arange(4.0 + i), f"c{i}"
        np.savez(tmp_path / f"PdM_{split}.npz", data=data, columns=np.array(["features", "label"], dtype=object))
    got = read_npz(spark, str(tmp_path), r"_TRAIN\.npz$", allow_pickle=True).orderBy("sample_id").collect()
    assert [(r.sample_id, r.label, r.series, r.split) for r in got] == [
        (i, f"c{i}", [float(x) for x in range(4 + i)], "TRAIN") for i in range(3)]
    with pytest.raises(Exception, match="allow_pickle"):
        read_npz(spark, str(tmp_path)).collect()
