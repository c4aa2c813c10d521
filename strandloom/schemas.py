"""Logical tables as DDL strings; inputs are read with these, never with inferred types."""

READ_SEGMENTS = "read_start BIGINT, read_end BIGINT, ref_start BIGINT, ref_end BIGINT, read_id STRING, ref_id STRING, strand STRING, read_length BIGINT, segment_length BIGINT, haplotype TINYINT, mapq INT, genome_id STRING, mismatch_rate DOUBLE, is_insertion BOOLEAN"
COVERAGE_HIST = "genome_id STRING, hp TINYINT, chr STRING, win BIGINT, depth BIGINT"
COVERAGE_BINS = "chr STRING, start BIGINT, end BIGINT, hp1 DOUBLE, hp2 DOUBLE, hp3 DOUBLE"
COVERAGE_BINS_UNPHASED = "chr STRING, start BIGINT, end BIGINT, coverage DOUBLE"
COVERAGE_PS = "chr STRING, start BIGINT, end BIGINT, hp1 DOUBLE, hp2 DOUBLE"
PHASESET_POSITIONS = "chr STRING, position BIGINT, phasesets BIGINT"
HET_SNPS = "chr STRING, start BIGINT, ref STRING, alt STRING, gt STRING"
ACGT_COUNTS = "chr STRING, start BIGINT, a INT, c INT, g INT, t INT"
SNPS_FREQUENCIES = "chr STRING, pos BIGINT, freq_value_a INT, hp_a INT, freq_value_b INT, hp_b INT"
SNPS_LOH = "chr STRING, pos BIGINT, qual DOUBLE, gt STRING, dp STRING, vaf STRING"
BAF = "chr STRING, pos BIGINT, vaf DOUBLE"
LOH_SEGMENTS = "chr STRING, start BIGINT, end BIGINT, hp INT"
PHASE_CHANGES = "chr STRING, start BIGINT, end BIGINT"
SEGMENTS_RAW = "chr STRING, start BIGINT, end BIGINT, state DOUBLE"
SEGMENTS_CN = "chr STRING, start BIGINT, end BIGINT, depth DOUBLE, state DOUBLE, confidence DOUBLE"
PROFILE = "chr STRING, start BIGINT, end BIGINT, hp1_coverage DOUBLE, hp1_copynumber_state DOUBLE, hp1_confidence DOUBLE, hp2_coverage DOUBLE, hp2_copynumber_state DOUBLE, hp2_confidence DOUBLE"
PROFILE_UNPHASED = "chr STRING, start BIGINT, end BIGINT, coverage DOUBLE, copynumber_state DOUBLE, confidence DOUBLE"
GENES = "chr STRING, start BIGINT, end BIGINT, gene STRING"
CENTROMERES = "chr STRING, start BIGINT, end BIGINT"
CONTIGS = "chr STRING, len BIGINT"
BREAKPOINTS = "id STRING, svtype STRING, chr1 STRING, pos1 BIGINT, chr2 STRING, pos2 BIGINT, hp STRING, dv INT, svlen BIGINT"
SOLUTIONS = "repository_name STRING, dna_purity DOUBLE, cell_purity DOUBLE, ploidy DOUBLE, confidence DOUBLE, solution_rank INT"
VARIANTS = "chr STRING, pos BIGINT, id STRING, ref STRING, alt STRING, qual DOUBLE, filter STRING, info STRING, format STRING, sample STRING"
