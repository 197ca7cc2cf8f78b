from titrate.operators import intake

ENTRIES = ["2001:db8::/33", "fe80::1", "10.1.0.0/16", "::/129", "0.0.0.0/33", "bad", "fd00::/ 8 "]
PEERS = {
    "2001:db8:0:1::9": True, "2001:DB8:7fff::": True, "2001:db8:8000::": False, "fe80::1": True, "fe80:0:0:0:0:0:0:1%2": True, "fe80::2": False,
    "fdff::1": True, "fc00::1": False, "10.1.255.7": True, "::ffff:10.1.2.3": True, "10.2.0.0": False, "host": False,
}


def test_ranges_of_both_families(spark):
    entries = spark.createDataFrame([(e,) for e in ENTRIES], "entry string")
    peers = spark.createDataFrame([(p,) for p in PEERS], "peer string")
    ranges = intake.allowed_ranges(entries)
    assert sorted(x.entry for x in ranges.collect() if x.low is None) == ["0.0.0.0/33", "::/129", "bad"]
    assert {x.peer: x.admitted for x in intake.admitted(peers, ranges).collect()} == PEERS


def test_whole_family(spark):
    ranges = intake.allowed_ranges(spark.createDataFrame([("::/0",)], "entry string"))
    peers = spark.createDataFrame([("1.2.3.4",), ("1::",)], "peer string")
    assert {x.peer: x.admitted for x in intake.admitted(peers, ranges).collect()} == {"1.2.3.4": False, "1::": True}
