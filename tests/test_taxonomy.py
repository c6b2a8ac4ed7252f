from __future__ import annotations

import json

import pytest
from conftest import rows_of

from mailloom import taxonomy as tx


def spec(**changes):
    from mailloom import fixed

    return {**fixed.TAXONOMY_V1, **changes}


def test_builtin_and_files_agree(tmp_path, tax):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec(changelog="other text")))
    loaded = tx.load_taxonomy(path=path)
    assert loaded == tax and loaded.content_hash == tax.content_hash
    yaml = pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text(yaml.safe_dump(spec()))
    assert tx.load_taxonomy(path=tmp_path / "t.yaml") == tax


def test_unknown_version():
    with pytest.raises(ValueError):
        tx.load_taxonomy("v9")


def test_hash_changes_with_content(tax):
    other = tx.parse_taxonomy(spec(version="v2"))
    assert len(tax.content_hash) == 16 and other.content_hash != tax.content_hash


def test_defaults_and_lower_case():
    t = tx.parse_taxonomy({"version": "x", "tags": [{"name": "a", "definition": "d"}],
                          "keyword_rules": [{"tag": "a", "keywords": ["HI There"]}]})
    assert t.keyword_rules[0].keywords == ("hi there",)
    assert t.keyword_rules[0].fields == ("subject",) and t.tags[0].subtags == ()


def test_budget(tax):
    assert tax.size() == tx.Size(-(-len(tax.prompt()) // 4), False)
    assert tax.size(10).over_budget and not tax.size(tax.size().tokens).over_budget


@pytest.mark.parametrize("bad, place", [
    ({"version": 3}, "version"), ({"version": "x"}, "tags"),
    ({"version": "x", "tags": [{"name": "a"}]}, r"tags\[0\]"),
    ({"version": "x", "tags": [{"name": "a", "definition": 1}]}, r"tags\[0\]\.definition"),
    ({"version": "x", "tags": [{"name": "a", "definition": "d", "subtags": "b"}]}, r"tags\[0\]\.subtags"),
    ({"version": "x", "tags": [{"name": "a", "definition": "d"}],
      "keyword_rules": [{"tag": "a", "keywords": [1]}]}, r"keyword_rules\[0\]\.keywords"),
])
def test_bad_entries_are_named(bad, place):
    with pytest.raises(tx.TaxonomyError, match=place):
        tx.parse_taxonomy(bad)


def test_leaves(spark, tax):
    assert tax.leaves == sorted(["keep", "receipt", "receipt/bank", "receipt/purchase",
                                 "receipt/subscription", "notification", "newsletter", "junk",
                                 "junk/marketing", "unclassified"])
    assert rows_of(tx.valid_leaves(tax.tags_frame(spark)), "leaf") == [(x,) for x in tax.leaves]


def test_tables_agree_with_value(spark, tax):
    tags, rules = tax.tags_frame(spark), tax.rules_frame(spark)
    assert tx.taxonomy_prompt(tags).first()["prompt"] == tax.prompt()
    assert "- receipt: Purchase" in tax.prompt() and "(subtags: junk/marketing)" in tax.prompt()
    size = tx.prompt_size(tags, 100).first()
    assert size["tokens"] == tax.size().tokens and size["over_budget"]
    first = tx.taxonomy_hash(tags, rules).first()["taxonomy_hash"]
    assert first == tax.content_hash
    bare = tx.Taxonomy("x", tax.tags)
    assert tx.taxonomy_hash(bare.tags_frame(spark), bare.rules_frame(spark)).first()[1] == bare.content_hash
    assert first == tx.taxonomy_hash(tags.repartition(3), rules.repartition(2)).first()["taxonomy_hash"]
    assert first != tx.taxonomy_hash(tags, rules.filter("rule_pos > 0")).first()["taxonomy_hash"]
    words = tx.exploded_keywords(rules)
    assert words.count() == 19 and words.filter("rule_pos = 0 AND kw_pos = 1").first()["keyword"] == "% off"


def test_system_prompt(tax):
    text = tax.system_prompt()
    assert tax.prompt() in text and '{"tag": "<one taxonomy tag>"' in text
