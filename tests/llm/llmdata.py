"""What the tests of this folder share."""

SF = "/root/testdata/sf0.001"
#: Columns that clash with names the operators use inside.
CLASH = "score string, lang_pred string, votes string, node long, key long, mix_prob string, component_id long, shingles string, gone_id long, n_shingles string"
BASE = "doc_id long, text string, lang string, source string, n_chars long"
