"""The reference workloads as compositions of operators."""
