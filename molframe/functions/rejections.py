"""Why reads get into no consensus: names, letters and keys of the counters."""

from __future__ import annotations

#: The letter with which a rejected read is tagged, by reason.
LETTERS = {
    "fragment_read": "F", "insufficient_reads": "I", "quality_too_low": "Q", "unmapped": "U", "mapped": "M", "too_many_ns": "N", "minority_alignment": "A", "secondary_or_supplementary": "S", "failed_qc": "f", "missing_umi": "u",
    "quality_trimmed": "T", "zero_length_after_trimming": "Z", "insufficient_overlap": "V", "orphan_consensus": "P", "indel_error_between_strands": "D", "clip_overlap_failed": "L", "high_duplex_disagreement": "H",
    "potential_collision": "C", "not_primary_fr_pair": "R", "downsampled": "d", "other": "O",
}
#: The counters of the statistics table, each after raw_reads_rejected_for_.
COUNTED = (
    "insufficient_support minority_alignment insufficient_strand_support low_base_quality excessive_n_bases no_valid_alignment low_mapping_quality n_bases_in_umi missing_umi not_passing_filter low_mean_quality "
    "insufficient_min_depth excessive_error_rate umi_too_short single_strand_only non_paired_reads potential_umi_collision orphan_consensus zero_bases_post_trimming not_primary_fr_pair r1_r2_overlap_too_short "
    "indel_error_between_strands high_duplex_disagreement clip_overlap_failed downsampled"
).split()
#: The counter of each reason that has one.
COUNTER = {
    "fragment_read": "non_paired_reads", "insufficient_reads": "insufficient_support", "quality_too_low": "low_base_quality", "unmapped": "no_valid_alignment", "too_many_ns": "excessive_n_bases", "minority_alignment": "minority_alignment",
    "failed_qc": "not_passing_filter", "missing_umi": "missing_umi", "zero_length_after_trimming": "zero_bases_post_trimming", "insufficient_overlap": "r1_r2_overlap_too_short", "orphan_consensus": "orphan_consensus",
    "indel_error_between_strands": "indel_error_between_strands", "clip_overlap_failed": "clip_overlap_failed", "high_duplex_disagreement": "high_duplex_disagreement", "potential_collision": "potential_umi_collision",
    "not_primary_fr_pair": "not_primary_fr_pair", "downsampled": "downsampled",
}
#: Counters that a simplex table has even at 0.
SIMPLEX = ("insufficient_support", "minority_alignment", "orphan_consensus", "zero_bases_post_trimming")
