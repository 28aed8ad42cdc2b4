"""Part of mediasift."""
