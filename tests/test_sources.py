import random
import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators.encode import fill
from loomtext.plans.options import AddedToken, EncodeOptions, Family, GenerationConfig, ModelConfig, Padding, Side, TokenizerConfig
from loomtext.sources import files
from loomtext.streaming.encode import batch_stream, encode_stream


def test_vocab_round_trip(spark, tmp_path):
    v = {"a": 0, "é</w>": 1, '"': 2}
    (tmp_path / "v.json").write_text(json.dumps(v))
    df = files.read_vocab(spark, str(tmp_path / "v.json"))
    assert {r.token: r.id for r in df.collect()} == v
    files.write_vocab(df, str(tmp_path / "out"))
    assert {r.token: r.id for r in files.read_vocab(spark, str(tmp_path / "out")).collect()} == v


def test_merges(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#version\nl o\nlo w</w>\ne r</w>\n")
    read = lambda **k: [tuple(r) for r in files.read_merges(spark, str(tmp_path / "m.txt"), **k).orderBy("rank").collect()]
    assert read() == [(0, "l", "o"), (1, "lo", "w</w>"), (2, "e", "r</w>")]
    assert len(read(most=2)) == 2 and len(read(drop_last=True)) == 2


@pytest.mark.parametrize(("kind", "type_", "value"), [("SingleInput", "string", "test"), ("BatchInput", "array<string>", ["test1", "test2", "test3"]), ("PretokenizedSingleInput", "array<string>", ["a", "b"]), ("PretokenizedBatchInput", "array<array<string>>", [["a"], ["b", "c"]])])
def test_input_json(spark, kind, type_, value):
    df = spark.createDataFrame([(value,)], f"v {type_}").select(files.input_json(F.col("v"), kind).alias("j"))
    assert json.loads(df.first().j) == {"Type": kind, "Value": value}
    p = df.select(files.parse_input_json(F.col("j")).alias("p")).first().p
    assert p.type == kind and p[kind] == value and sum(x is not None for x in p) == 2


def test_configs(spark, tmp_path):
    raw = {"bos_token": {"__type": "AddedToken", "content": "<s>", "lstrip": True}, "eos_token": "</s>", "added_tokens_decoder": {"5": {"content": "<x>", "special": True}}, "padding_side": "left", "chat_template": "ignored", "model_max_length": 10**30}
    (tmp_path / "t.json").write_text(json.dumps(raw))
    c = files.read_tokenizer_config(spark, str(tmp_path / "t.json"))
    assert c.bos_token.lstrip and c.eos_token.content == "</s>" and c.added_tokens == (AddedToken("<x>", 5, special=True),)
    assert c.padding_side == Side.LEFT and c.model_max_length == 2**31 - 1 and c.special_tokens() == ["<s>", "</s>"]
    assert not c.added_tokens[0].normalized
    with pytest.raises(ValueError):
        AddedToken.parse({"content": "x"}, tagged=True)
    g = GenerationConfig.from_json('{"eos_token_id": 2, "max_new_tokens": 5, "other": 1}')
    assert g.eos_token_id == (2,) and GenerationConfig.from_json(g.to_json()) == g and g.extra == {"other": 1}
    assert ModelConfig.from_json('{"vocab_size": 7, "architectures": ["x"], "more": 1}') == ModelConfig(vocab_size=7, architectures=("x",))
    assert TokenizerConfig.from_json("{}").model_input_names[0] == "input_ids"


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, [1] * i) for i in range(1, 4)], "id int, ids array<int>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ids array<int>").parquet(str(tmp_path / "in"))
    seen = []
    q = encode_stream(stream, "ids", EncodeOptions(padding=Padding.LONGEST), Family.WORD_END, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp"), bos_id=8, eos_id=9)
    q.awaitTermination(60)
    assert {len(r.input_ids) for r in seen} == {5} and len(seen) == 3


def test_fill(spark):
    assert spark.range(1).select(fill(3, 2), fill(3, -1)).first()[:] == ([3, 3], [])


def test_batches_fill_over_micro_batches_and_restarts(spark, tmp_path):
    """Four files, one a micro-batch, with a restart after two: each lane's rows in order, size by size; the rest goes out by the watermark."""
    rng = random.Random(20)
    rows = [(i, i % 3, None if i == 7 else [rng.randint(1, 9) for _ in range(rng.randint(0, 6))], i + 1) for i in range(41)]
    schema = "row int, lane int, ids array<int>, t long"

    def write(part, k):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        filled = batch_stream(stream.withColumn("time", F.timestamp_seconds("t")), F.col("lane"), "row", "ids", "time", 4, pad_id=-1)
        filled.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    write(rows[:9], 0)
    write(rows[9:20], 1)
    run()
    write(rows[20:41], 2)
    write([(1000, 9, [1], 10_000)], 3)  # later than all others: the watermark passes every row that waits
    run()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault((r.lane, r.batch), {})[int(r.row)] = (r.input_ids, r.attention_mask)
    for lane in range(3):
        own = [x for x in rows if x[1] == lane]
        # rows that wait leave by the watermark of the micro-batch before, so batches may be short where files end
        order = [row for b in sorted(b for k, b in got if k == lane) for row in sorted(got[lane, b])]
        assert order == [x[0] for x in own]
    for batch in got.values():
        ids = {k: rows[k][2] or [] for k in batch}
        longest = max(map(len, ids.values()))
        assert len(batch) <= 4 and all(batch[k] == (x + [-1] * (longest - len(x)), [1] * len(x) + [0] * (longest - len(x))) for k, x in ids.items())
    assert sum(len(b) == 4 for b in got.values()) >= 6 and (9, 0) not in got


def test_batches_of_a_lane_leave_a_few_at_a_time(spark):
    import pandas as pd

    class Plan:
        select = withWatermark = groupBy = lambda self, *a: self
        applyInPandasWithState = lambda self, f, *a: f

    class State:
        exists = hasTimedOut = False
        update = setTimeoutTimestamp = lambda self, x: setattr(self, "last", x)
        getCurrentWatermarkMs = lambda self: 0

    n = 5000
    part = pd.DataFrame({"lane_": 0, "row_": [f"{i:05d}" for i in range(n)], "ids_": [[i % 7] * (i % 5) for i in range(n)], "time_": pd.to_datetime(list(range(n))[::-1], unit="s")})
    fill = batch_stream(Plan(), F.lit(0), "row", "ids", "time", 16)
    frames = list(fill((0,), iter([part]), State()))
    assert max(map(len, frames)) <= 1040 and sum(map(len, frames)) == n // 16 * 16
    assert [r for f in frames for r in f["row"]] == [f"{i:05d}" for i in range(n)][::-1][: n // 16 * 16]
