"""Queries without SQL that must take whole tables, against plain readings of them."""

from collections import defaultdict

from apisieve.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_export_resolution(spark):
    rows = {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("part", "lineitem", "supplier", "nation", "region")}
    own = {(f"part:{r.p_partkey}", f"{r.p_name} {r.p_type} {r.p_size}"): r.p_brand for r in rows["part"]}
    stars = {(f"supplier:{r.l_suppkey}", f"part:{r.l_partkey}") for r in rows["lineitem"]}
    stars |= {(f"nation:{r.s_nationkey}", f"supplier:{r.s_suppkey}") for r in rows["supplier"]}
    stars |= {(f"region:{r.n_regionkey}", f"nation:{r.n_nationkey}") for r in rows["nation"]}
    stars |= {(f"region:{r.r_regionkey}", f"region:{(r.r_regionkey + 1) % len(rows['region'])}") for r in rows["region"]}
    sources, own_of = defaultdict(list), defaultdict(dict)
    for module, source in stars:
        sources[module].append(source)
    for (module, name), target in own.items():
        own_of[module][name] = target
    want = dict(own)
    for start in list(sources):  # all targets of a name within reach, own exports hiding what lies behind them
        reached, stack, found = {start}, [start], defaultdict(set)
        while stack:
            for source in sources.get(stack.pop(), ()):
                if source not in reached:
                    reached.add(source)
                    stack.append(source)
                    for name, target in own_of[source].items():
                        found[name].add(target)
        want |= {(start, name): min(t) if len(t) == 1 else "ambiguous" for name, t in found.items()}
    got = QUERIES["export_resolution"](spark, SF).collect()
    assert {(r.module, r.name): r.target for r in got} == want and len(got) == len(want)
    assert len({r.module for r in got if r.module.startswith("part:")}) == len(rows["part"])


def test_every_script_block_of_a_page(spark, tmp_path):
    html = ["<script>track(1)</script>", "<p>none</p>", "<script a='b'>\nother(5)</script><p><script>track(2)\ntrack(3)</script>", None]
    rows = [(k, f"http://a/{k}", h) for k, h in enumerate(html)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["page_script_calls"](spark, str(tmp_path)).collect()
    assert sorted(r.path for r in got) == ["0", "2#1", "2#1"]
    assert len({(r.path, r.fact_id) for r in got}) == 3
