"""chronolake.plans"""
