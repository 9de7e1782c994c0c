from railyard.sources.stored import StoredDomain


def test_stored_domain_writes_once_and_reads_back(spark, seed, tmp_path):
    sd = StoredDomain(seed, str(tmp_path / "dom"))
    t = sd["tickets"]
    assert "issue_month" in t.columns and t.count() == 20
    (copy,) = (tmp_path / "dom" / "tickets").iterdir()
    assert (copy / "_SUCCESS").exists()
    again = StoredDomain(seed, str(tmp_path / "dom"))
    assert again._stored("tickets") and again["tickets"].count() == 20
    assert len(list((tmp_path / "dom" / "tickets").iterdir())) == 1
    assert sorted(r.id for r in sd["bookings"].collect()) == list(range(20))


def test_half_written_copy_and_second_writer(spark, seed, tmp_path):
    half = tmp_path / "dom" / "bookings" / "0-half"
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"")
    one, two = StoredDomain(seed, str(tmp_path / "dom")), StoredDomain(seed, str(tmp_path / "dom"))
    two._stored = lambda name: None             # as if both had looked before either wrote
    assert one["bookings"].count() == two["bookings"].count() == 20
    assert StoredDomain(seed, str(tmp_path / "dom"))["bookings"].count() == 20
