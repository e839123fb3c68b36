"""Fixed tables that the analyses join with."""
