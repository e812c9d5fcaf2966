"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can say it."""

from . import alignment, ann, divergence, language_id, licenses, line_dedup, media, minmax, ngram_jaccard, packing, quality, sentencepiece_codec, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard.op1_ngram_jaccard_join,
    "op2_warc": warc.op2_warc,
    "op3_language_id": language_id.op3_language_id,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_media_columns": media.op8_media_columns,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_nearest_neighbours": ann.op10_nearest_neighbours,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_minmax_near_dedup": minmax.op12_minmax_near_dedup,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": ngram_jaccard.ORACLE,
    "op2_warc": warc.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op12_minmax_near_dedup": minmax.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
