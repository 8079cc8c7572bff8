"""Plans over several tables: what a promotion, a copy or a discovery run would do."""
