import gzip
import hashlib

from chatsift.llm import warc

SCHEMA = "page_id long, url string, html string, record string, block int"


def rows(spark, data):
    return warc.derivatives(warc.responses(spark.createDataFrame(data, SCHEMA)), ("page_id",)).collect()


def test_records_refer_to_their_response(spark):
    html = '<html lang="fr"><head><title>A&amp;B</title><script>x<y</script></head><body><p>One  two<br>three <a href="/x">l</a></p></body></html>'
    got = rows(spark, [(1, "http://h/a", html, "x", 1), (2, None, None, None, None), (3, "http://h/b", "", "x", 1), (1, "http://h/a", html, "x", 1)])
    assert len(got) == 8
    one = {r.warc_type: r for r in got if r.page_id == 1}
    meta, conv = one["metadata"], one["conversion"]
    assert conv.block == "A&B\nOne two\nthree l"
    assert meta.refers_to == conv.refers_to != meta.record_id != conv.record_id
    assert "language: fr\r\n" in meta.block and "outlinks: 1\r\n" in meta.block
    assert meta.payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    for r in got:
        head, _, block = r.record.partition("\r\n\r\n")
        assert block == r.block and head.startswith("WARC/1.1\r\nWARC-Type: " + r.warc_type)
        fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
        assert fields["WARC-Refers-To"] == r.refers_to and int(fields["Content-Length"]) == len(r.block.encode())
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert ("WARC-Target-URI" in fields) == (r.target_uri is not None)
    assert [r.block for r in got if r.page_id in (2, 3) and r.warc_type == "conversion"] == ["", ""]
    assert rows(spark, []) == []


def test_written_files_read_back(spark, tmp_path):
    df = warc.derivatives(warc.responses(spark.createDataFrame(
        [(i, f"http://h/{i}", f"<p>é{i}\r\n\r\nx</p>", "x", 1) for i in range(5)], SCHEMA)))
    warc.write_warc(df.coalesce(1), str(tmp_path / "out"))
    raw = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    found = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        found.append((head + b"\r\n\r\n" + rest[:n]).decode())
        assert rest[n : n + 4] == b"\r\n\r\n"
        raw = rest[n + 4 :]
    assert sorted(found) == sorted(r.record for r in df.collect())


def test_all_character_references_are_decoded_once(spark):
    html = ("<p>It&#8217;s &#x2014; caf&eacute;&hellip; &mdash; &#39;x&#39; &amp;eacute; &amp;#233; &amp;lt; a&nbsp;b&#160;&#xA0;c "
            "&notareference; AT&T R&D &copy; &#x1F600; &lt;p&gt; &CounterClockwiseContourIntegral; &#0; x&#9;y&#13;&#10;z</p>")
    expected = ("It’s — café… — 'x' &eacute; &#233; &lt; a b c ¬areference; AT&T R&D © 😀 <p> ∳ � x y z")
    got = {r.warc_type: r for r in rows(spark, [(1, "http://h/a", html, "x", 1)])}
    conv = got["conversion"]
    assert conv.block == expected and conv.content_length == len(expected.encode())
    assert conv.block_digest == "sha256:" + hashlib.sha256(expected.encode()).hexdigest()
    assert f"textLength: {len(expected.encode())}\r\n" in got["metadata"].block
