"""Part of Mnemora."""
