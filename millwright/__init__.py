"""Millwright: supply-chain, inspection and corpus analytics as Spark DataFrame operators."""
