"""A PySpark-native engine for screening and ranking large peptide libraries."""
