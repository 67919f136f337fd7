"""What operators hold in memory and write beside their results."""

from netloom.llm import token_files, tokens


def test_token_files_leave_room_for_the_writer():
    path = tokens.vocabulary()
    made = tokens.encoder(path, token_files.SHARE)
    assert made.pieces.most < tokens.REMEMBERED and made.parts.most < tokens.REMEMBERED_PARTS
    try:
        made.pieces.most = made.parts.most = 4  # forgets all the time
        texts = [f"word{k % 7} and word{k % 5}, again {k}" for k in range(300)]
        for at in range(0, 300, 20):
            assert made.encode(texts[at : at + 20]) == made.wholes(texts[at : at + 20])
            assert len(made.pieces.new) <= 4 + 60
    finally:
        assert tokens.encoder(path).pieces.most == tokens.REMEMBERED


def test_repeated_strings_write_each_segment_once(spark):
    from pathlib import Path

    from netloom.llm import suffixes
    from netloom.sources.kept import shared_dir

    from ..conftest import SF

    folder = Path(shared_dir(spark)) / "netloom"
    before = set(folder.glob("*"))
    suffixes.digests(spark.read.parquet(f"{SF}/documents.parquet")).count()
    new = sorted(p.name.split("-")[0] for p in set(folder.glob("*")) - before)
    assert "segments" in new and "pieces" in new and "asked" not in new
